"""Canonical licence texts and notices, as they stand in files, and the SPDX names that a scan must give."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY {0} "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL {1} BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_HOLDERS = _BSD_TAIL.format("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS")
BSD2 = _BSD_HEAD + _HOLDERS
BSD3 = _BSD_HEAD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""" + _HOLDERS
BSD3_NAMED = BSD3.replace("the copyright holder nor", "Some Widgets Inc. nor")
BSD3_REGENTS = BSD3.replace("the copyright holder nor", "the University nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS")
BSD4 = _BSD_HEAD + """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
     This product includes software developed by the Example Organization.

4. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""" + _BSD_TAIL.format("COPYRIGHT HOLDER", "COPYRIGHT HOLDER")

APACHE2 = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
APACHE11 = _BSD_HEAD + """
3. The end-user documentation included with the redistribution, if any, must
   include the following acknowledgment: "This product includes software
   developed by the Apache Software Foundation (http://www.apache.org/)."
   Alternately, this acknowledgment may appear in the software itself, if and
   wherever such third-party acknowledgments normally appear.

4. The names "Apache" and "Apache Software Foundation" must not be used to
   endorse or promote products derived from this software without prior
   written permission. For written permission, please contact apache@apache.org.

5. Products derived from this software may not be called "Apache", nor may
   "Apache" appear in their name, without prior written permission of the
   Apache Software Foundation.

THIS SOFTWARE IS PROVIDED "AS IS" AND ANY EXPRESSED OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""


def gnu(what, licence, version, mark):
    return f"""{what} is free software{mark} you can redistribute it and/or modify
it under the terms of the {licence} as published by
the Free Software Foundation{"," if mark == ":" else ";"} either version {version} of the License, or
(at your option) any later version.

{what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{licence} for more details.

You should have received a copy of the {licence}
along with {what.lower()}""" + (".  If not, see <https://www.gnu.org/licenses/>." if mark == ":" else "; if not, write to the Free Software\nFoundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")


GPL3 = gnu("This program", "GNU General Public License", "3", ":")
GPL2 = gnu("This program", "GNU General Public License", "2", ";")
LGPL21 = gnu("This library", "GNU Lesser General Public License", "2.1", ";")
LGPL2 = gnu("This library", "GNU Library General Public License", "2", ";")
LGPL3 = gnu("This program", "GNU Lesser General Public License", "3", ":")
AGPL3 = gnu("Some Server", "GNU Affero General Public License", "3", ":")
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""

MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software."
EPL2 = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""

TEXTS = (
    (MIT, "MIT"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (BSD3_NAMED, "BSD-3-Clause"), (BSD3_REGENTS, "BSD-3-Clause"), (BSD4, "BSD-4-Clause"),
    (APACHE2, "Apache-2.0"), (APACHE11, "Apache-1.1"), (GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (LGPL21, "LGPL-2.1-or-later"),
    (LGPL2, "LGPL-2.0-or-later"), (LGPL3, "LGPL-3.0-or-later"), (AGPL3, "AGPL-3.0-or-later"), (GPL2_ONLY, "GPL-2.0-only"), (MPL2, "MPL-2.0"),
    (ISC, "ISC"), (ZLIB, "Zlib"), (UNLICENSE, "Unlicense"), (EPL2, "EPL-2.0"),
)
SHAPES = {
    "wrapped": lambda t: t,
    "one line": lambda t: " ".join(t.split()),
    "hash": lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")),
    "slashes": lambda t: "\n".join(f"// {x}".rstrip() for x in t.split("\n")),
    "stars": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */",
    "dashes": lambda t: "\n".join(f"-- {x}".rstrip() for x in t.split("\n")),
    "semicolons": lambda t: "\n".join(f";; {x}".rstrip() for x in t.split("\n")),
    "rem": lambda t: "\n".join(f"REM {x}".rstrip() for x in t.split("\n")),
    "carriage returns": lambda t: t.replace("\n", "\r\n"),
    "prose around": lambda t: "Some heading\n\nCopyright (c) 2020 Some Widgets Inc.\n" + t + "\nint main(void);",
}
